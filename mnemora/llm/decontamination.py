"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, and one scan of every text.

Texts and items are brought to the same words: A-Z in lower case, cut at everything in ASCII that is no letter or digit.
The automaton's letters are the items' words; its patterns are all windows of so many words that follow each other in an
item. A text is walked once, word by word; the words of a match are mapped back to characters of the text as it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, sheltered, written

#: Words of a window.
SIZE = 10
#: Words in the windows of one automaton, with one more for each item of a window: what a worker holds (some 100 MB)
#: and what is broadcast (some 5 MB) are bounded by it. More windows make more automata, each with a scan of its own.
STATES = 500_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By UTF-8 byte: A-Z as a-z, digits and all that is not ASCII as they are, the rest as a space.
_PLAIN = bytes(b if b >= 128 or chr(b) in _LOWER + "0123456789" else b + 32 if chr(b) in _UPPER else 32 for b in range(256))
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPAN = "struct<item:string,first_word:long,last_word:long,start:long,end:long>"
FOUND = f"struct<n_words:long,n_hit:long,spans:array<{SPAN}>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("item", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), 0), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window array<string>, items array<string>): the distinct windows of all items, each with the items that have it,
    a null among them for items without an id.

    An item of fewer words than `size` is one window; one without words has none.
    """
    w = items.select(F.col(id_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    each = w.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, F.lit(size)))).alias("window"))
    return each.groupBy("window").agg(F.collect_set(F.struct("_item"))["_item"].alias("items"))


class Automaton:
    """Aho-Corasick over words. goto: state * words + word -> state; fail: the state of the longest proper suffix that is
    a state; link: the next state, along fail, at which a window ends."""

    def __init__(self, windows: Sequence[tuple[Sequence[str], Sequence[str]]]):
        self.number: dict[bytes, int] = {}
        coded = [([self.number.setdefault(w.encode(), len(self.number)) for w in window], items) for window, items in windows]
        self.base = max(len(self.number), 1)
        self.goto: dict[int, int] = {}
        self.ends: list[tuple[int, Sequence[str]] | None] = [None]
        by_depth: list[list[tuple[int, int, int]]] = []  # (state, word, new state) at each depth
        for window, items in coded:
            state = 0
            for depth, w in enumerate(window):
                key = state * self.base + w
                new = self.goto.get(key)
                if new is None:
                    new = self.goto[key] = len(self.ends)
                    self.ends.append(None)
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append((state, w, new))
                state = new
            self.ends[state] = (len(window), items)
        self.fail, self.link = [0] * len(self.ends), [0] * len(self.ends)
        for level in by_depth[1:]:
            for parent, w, state in level:
                back = self.fail[parent]
                while back and back * self.base + w not in self.goto:
                    back = self.fail[back]
                self.fail[state] = back = self.goto.get(back * self.base + w, 0)
                self.link[state] = back if self.ends[back] else self.link[back]
        self.stops = [bool(e) or bool(k) for e, k in zip(self.ends, self.link)]

    def matches(self, text_words: Sequence[bytes]) -> Iterator[tuple[int, int, Sequence[str]]]:
        """(first word, last word, items) of every occurrence of a window, by last word."""
        goto, fail, stops, base, state = self.goto.get, self.fail, self.stops, self.base, 0
        for i, w in enumerate(map(self.number.get, text_words)):
            if w is None:
                state = 0
                continue
            new = goto(state * base + w)
            while new is None and state:
                state = fail[state]
                new = goto(state * base + w)
            state = new or 0
            if stops[state]:
                at = state if self.ends[state] else self.link[state]
                while at:
                    length, items = self.ends[at]  # type: ignore[misc]
                    yield i - length + 1, i, items
                    at = self.link[at]

    def find(self, raw: bytes | None) -> dict:
        """FOUND of a text in UTF-8."""
        raw = raw or b""
        text_words = raw.translate(_PLAIN).split()
        hit, spans = joined([(a, b, item, 0, 0) for a, b, items in self.matches(text_words) for item in items])
        if spans:
            places = [m.span() for m in _RUN.finditer(raw)]
            chars, at, done = {0: 0}, 0, 0
            for mark in sorted({places[s[0]][0] for s in spans} | {places[s[1]][1] for s in spans}):
                done += len(raw[at:mark].decode("utf-8", "replace"))
                at, chars[mark] = mark, done
            spans = [(a, b, item, chars[places[a][0]], chars[places[b][1]]) for a, b, item, _, _ in spans]
        return as_found(len(text_words), hit, spans)


Span = tuple[int, int, str | None, int, int]


def joined(spans: list[Span]) -> tuple[int, list[Span]]:
    """The number of words in any of (first word, last word, item, start, end), and the spans with those of an item that overlap
    or touch as one."""
    out: list[list] = []
    open_: dict[str | None, list] = {}
    hit, upto = 0, -1
    for first, last, item, start, end in sorted(spans, key=lambda s: s[:2]):
        hit += max(last - max(first - 1, upto), 0)
        upto = max(upto, last)
        old = open_.get(item)
        if old is None or first > old[1] + 1:
            open_[item] = new = [first, last, item, start, end]
            out.append(new)
        elif last > old[1]:
            old[1], old[4] = last, end
    return hit, sorted((tuple(s) for s in out), key=lambda s: (s[0], s[1], s[2] or ""))


def as_found(n_words: int, hit: int, spans: list[Span]) -> dict:
    return {"n_words": n_words, "n_hit": hit, "spans": [dict(zip(("first_word", "last_word", "item", "start", "end"), s)) for s in spans], "items": sorted({s[2] for s in spans if s[2] is not None})}


class Windows:
    """What is broadcast; each worker builds the automaton once."""

    def __init__(self, windows: list[tuple[list[str], list[str]]]):
        self.windows = windows

    def automaton(self) -> Automaton:
        if "_built" not in self.__dict__:
            self._built = Automaton(self.windows)
        return self._built

    def __getstate__(self) -> dict:
        return {"windows": self.windows}


def _finder(docs: DataFrame, windows: DataFrame) -> Callable[[Column], Column]:
    """From a column of texts to FOUND, by one automaton over these windows."""
    rows = [(list(r["window"]), list(r["items"])) for r in windows.select("window", "items").collect()]  # STATES words
    sent = docs.sparkSession.sparkContext.broadcast(Windows(rows))

    @F.arrow_udf(FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = sent.value.automaton()
        for t in texts:
            yield pa.array([automaton.find(x) for x in t.to_pylist()], _FOUND)

    return lambda text: find(text.cast("binary"))


def find_contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", states: int = STATES) -> DataFrame:
    """docs with n_words, n_hit, spans and items.

    A word is hit if it lies in an occurrence of a window of an item: `size` words that follow each other in it, or all
    its words if it has fewer. items: the sorted distinct ids, as strings, of those with an occurrence. spans: for each
    item its occurrences, those that overlap or touch as one, by first and last word (from 0), and by characters of the text as
    it is (start from 0, end exclusive), so text[start:end] is what to cut or to show.

    A null text has no words. An item without words or text is not looked for; one without an id hits words and is not
    listed; items of equal ids are one item; equal windows are one window, whosoever they are. Texts are scanned whole,
    however long, row by row: repeated rows are scanned like others, an empty table gives an empty table, and without
    items nothing is hit. Columns of docs named as the new ones are replaced.

    The automaton is bounded by `states`. Where the items have more, their windows are dealt to several by hash; the
    first scan gives every text its row, each other one the texts that it finds something in, which are then merged.
    """
    found = written(item_windows(items, size, item_id_col, item_text_col), "windows")
    cost = found.agg(F.sum(F.size("window") + F.size("items"))).first()[0] or 0
    parts = max(1, -(-cost // states))
    d, (text,) = sheltered(docs, text_col)
    t = F.col(text)
    part = lambda k: found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
    d = d.withColumn("_found", _finder(docs, part(0))(t))
    if parts > 1:
        d = _merged(d, t, [_finder(docs, part(k)) for k in range(1, parts)])
    return restored(d, docs.columns, {k: F.col(f"_found.{k}") for k in ("n_words", "n_hit", "spans", "items")})


def _merged(d: DataFrame, text: Column, others: list[Callable[[Column], Column]]) -> DataFrame:
    """d with what the other automata find, too. Texts meet what was found in them by their digests."""
    key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    d = d.withColumn("_key", key)
    hits = [d.select("_key", f(text).alias("_more")).where("_more.n_hit > 0") for f in others]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    spans = written(every.select("_key", F.explode("_more.spans").alias("s")).distinct(), "spans-more")
    more = spans.groupBy("_key").agg(F.collect_list("s").alias("_spans"))
    met = d.join(more, "_key", "left")
    both = F.concat("_found.spans", F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")))

    @F.arrow_udf(FOUND)
    def unite(n: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for words_, found in zip(n.to_pylist(), spans.to_pylist()):
            out.append(as_found(words_, *joined([(s["first_word"], s["last_word"], s["item"], s["start"], s["end"]) for s in found or []])))
        return pa.array(out, _FOUND)

    return met.withColumn("_found", F.when(F.col("_spans").isNull(), F.col("_found")).otherwise(unite(F.col("_found.n_words"), both))).drop("_key", "_spans")
