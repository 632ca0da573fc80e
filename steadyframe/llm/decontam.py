"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.llm.common import append_columns

#: ASCII bytes outside words become spaces, A-Z become a-z; other bytes stay.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("clean_text", T.StringType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("contaminated", T.BooleanType()),
]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids, with what a window of ``window`` words needs.

    ``window_items[s]``: items that hold the window-long suffix of state ``s``. ``short_up[s]``: the
    nearest of ``s`` and its suffix links that is a whole item shorter than the window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = window
        number = self.vocabulary
        owners: dict[int, set[str]] = defaultdict(set)
        whole: dict[int, set[str]] = defaultdict(set)
        pairs: set[tuple[int, int]] = set()
        coded = [(item, [number.setdefault(w, len(number)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            self.shortest = min(self.shortest, len(word_ids))
            pairs.update(zip(word_ids, word_ids[1:]))
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        for item, word_ids in coded:
            state = 0
            for w in word_ids:
                state = self.next[state][w]
                s = self._at(state, window)
                if s is not None:
                    owners[s].add(item)
            if len(word_ids) < window:
                whole[state].add(item)
        self.window_state = [self._at(s, window) for s in range(len(self.len))]
        self.window_items = {s: sorted(x) for s, x in owners.items()}
        self.whole = {s: sorted(x) for s, x in whole.items()}
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.short_up = [-1] * len(order)
        for s in order:
            self.short_up[s] = s if s in whole else self.short_up[self.link[s]] if s else -1
        self.table = np.zeros(1 << 22, dtype=bool)
        if pairs:
            a = np.array(sorted(pairs), dtype=np.int64)
            self.table[self._slot(a[:, 0], a[:, 1])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & ((1 << 22) - 1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _at(self, s: int, length: int) -> int | None:
        """The state of the suffix of this length of the strings of ``s``; None if they are shorter."""
        if self.len[s] < length:
            return None
        while self.len[self.link[s]] >= length:
            s = self.link[s]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [start, end) of words inside occurrences of windows, and the items that hold those windows."""
        n, least = len(words), self.shortest
        if n < least or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=n)
        good = ids >= 0
        if least >= 2:  # only stretches whose neighbours are neighbours in some item can hold a window
            pair = good[1:] & good[:-1]
            at = np.flatnonzero(pair)
            pair[at] = self.table[self._slot(ids[at], ids[at + 1])]
            good = pair
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        need = max(1, least - 1)
        starts, ends = edge[::2], edge[1::2] + (least >= 2)
        long_ = ends - starts >= need + (least >= 2)
        spans: list[list[int]] = []
        items: set[str] = set()
        for a, b in zip(starts[long_].tolist(), ends[long_].tolist()):
            self._walk(ids[a:b].tolist(), a, spans, items)
        return [(a, b) for a, b in _merged(spans)], items

    def _walk(self, ids: list[int], base: int, spans: list[list[int]], items: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = matched = 0
        for i, w in enumerate(ids):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w not in nxt[state]:
                continue
            state = nxt[state][w]
            matched += 1
            covered = 0
            if matched >= window:
                covered = matched
                items.update(self.window_items[self.window_state[state]])
            s = self.short_up[state]
            if s == state and matched < length[s]:
                s = self.short_up[link[s]]
            while s > 0:
                covered = max(covered, length[s])
                items.update(self.whole[s])
                s = self.short_up[link[s]]
            if covered:
                a, b = base + i + 1 - covered, base + i + 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                    spans[-1][0] = min(spans[-1][0], a)
                else:
                    spans.append([a, b])


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 100_000,
) -> DataFrame:
    """Add n_words, n_hit, item_ids, spans (characters), clean_text, coverage and contaminated to ``docs``.

    A document word is hit inside any occurrence of ``window`` consecutive words of an item, or of a whole
    shorter item. ``clean_text`` lacks the hit spans. The items are taken in blocks of about ``block_words`` words (one
    item may be longer), which bounds the automaton that is broadcast (about 1 KB a word, so 100 MB in each Python worker); documents stream past one after the other, so
    neither side is shuffled, and an empty table of documents gives an empty one. Very long texts are scanned whole; repeated rows are each marked. Null or empty texts have no words and no hits; null item ids or texts are no items;
    equal ids count once; input columns named like an added one are replaced.
    """
    out, block = docs.drop(*[f.name for f in FIELDS]), None
    for following in _blocks(benchmark, item_col, item_text_col, block_words):
        if block:
            if "__spans" not in out.columns:
                out = out.withColumn("__spans", F.lit(None).cast("array<array<long>>")).withColumn("__items", F.lit(None).cast("array<string>"))
            out = _pass(out, text_col, Automaton(block, window))
        block = following
    return _finished(out, text_col, Automaton(block or [], window)).drop("__spans", "__items")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    block, n = [], 0
    for row in items.orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if n and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row["i"], words))
        n += len(words)
    if n:
        yield block


def _scanner(held):
    own = Automaton.__new__(Automaton)
    own.__dict__.update(held.value)
    return own.scan


def _found(scan, words: list[bytes], spans: list | None, items: list | None) -> tuple[list | None, list | None]:
    """What earlier blocks found with what this block's automaton adds."""
    more, names = scan(words)
    if not more:
        return spans, items
    return [list(x) for x in _merged([*map(tuple, spans or []), *more])], sorted({*(items or []), *names})


def _pass(docs: DataFrame, text_col: str, automaton: Automaton) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vars(automaton))
    fields = [docs.schema["__spans"], docs.schema["__items"]]

    def make():
        scan = _scanner(held)

        def step(batch):
            both = [_found(scan, words_of(t.as_py()), s, i) for t, s, i in zip(batch.column(text_col), batch.column("__spans").to_pylist(), batch.column("__items").to_pylist())]
            return {"__spans": [x[0] for x in both], "__items": [x[1] for x in both]}

        return step

    return append_columns(docs, fields, make)


def _finished(docs: DataFrame, text_col: str, automaton: Automaton) -> DataFrame:
    """The last block's pass, with the columns that are given."""
    held = docs.sparkSession.sparkContext.broadcast(vars(automaton))
    earlier = "__spans" in docs.columns

    def make():
        scan = _scanner(held)

        def step(batch):
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            none = [None] * batch.num_rows
            known = (batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()) if earlier else (none, none)
            for text, spans, items in zip(batch.column(text_col), *known):
                text = text.as_py()
                words = words_of(text)
                spans, items = _found(scan, words, spans, items)
                n, hit, at, clean = len(words), 0, [], text
                if spans:
                    places = [m.span() for m in WORD.finditer(text)]
                    at = [(places[a][0], places[b - 1][1]) for a, b in spans]
                    hit = sum(b - a for a, b in spans)
                    ends = [0, *(b for _, b in at)]
                    clean = "".join(text[e:a] for e, (a, _) in zip(ends, at)) + text[ends[-1] :]
                for name, v in zip(out, (n, hit, items or [], [{"start": a, "end": b} for a, b in at], clean, hit / n if n else 0.0, hit > 0)):
                    out[name].append(v)
            return out

        return step

    return append_columns(docs, FIELDS, make)
