"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: words (runs of letters, digits and bytes of
other scripts) in lower case, with numbers, names and units replaced by typed
placeholders, and neighbouring words of one type taken together (``New York`` and ``1,250``
are one slot each). Windows of ``WINDOW`` template tokens are joined by hash, so an item whose
numbers or names were changed still meets its copy. Adjacent hits on one diagonal make a
run; an item is held when one run covers ``least`` of its tokens (or the whole item, if
shorter), or when its runs together cover half of it and as many. Enough of the tokens must
be plain words, and the slots consistent: values of the item and of the document go together
one to one. Word for word copies count whatever their words are.

- number: a word that begins with a digit, and a number word (fixed list).
- name: a capitalised word (not all in capitals) that does not begin a sentence or a line and is
  no word of ``OPENERS``. Whether a capital at the beginning of a sentence makes a name cannot be
  told, so texts and items are compared twice, once with such words plain and once as names; in items
  of fewer than ``WINDOW`` tokens such a word must be the very word.
- unit: a word of the fixed list after a number and one space or hyphen.

An item whose template has fewer than ``SHORTEST`` tokens, or no plain word, is compared by its
words alone. What is found of an item depends on that item and the text of one row only. So a
benchmark of any size is read in blocks of bounded size, each sent to every task; texts are never
shuffled, every row, whatever its doc_id, is judged alike, and n blocks cost n readings.

Result rows: doc_id, item_id, token_start, token_end (words of the document), n_tokens (of the
template), n_slots, changed (slots whose value differs). Clean documents have no row. Null texts
and items, items of fewer than ``SHORTEST`` words and empty tables give no rows; rows that
repeat are reported once. Items with a null item_id are ignored. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ..store import materialize
from ._filter import only

WINDOW = 8
LEAST = 13
SHORTEST = 5
#: Windows of the benchmark in a block, about; every task holds one block at a time (two forms of 16 bytes each).
MAX_BROADCAST = 2_000_000
PLAIN_SHARE = 0.6

# Words that stand for numbers, units of measure and money, and words that begin sentences without being names.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mph kmh watt watts volt volts joule joules".split()
OPENERS = "a about after all also although an and another any are as at because before both but by can could did do does during each every few find first for from give given had has have he her here his how however if in into is it its let many most my no not now of on once only or our she should since so some suppose than that the their them then there these they this those through to two under until we were what when where whether which while who whom whose why will with would you your".split()

_WORD = np.zeros(256, dtype=bool)  # bytes of words
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BREAK = ~_WORD
_STOP = np.zeros(256, dtype=bool)  # ends a sentence or a line
_STOP[[10, 13, 33, 46, 58, 63]] = True

NUMBER, NAME, UNIT = H.stream64(3, 41)
PLAIN, NAMED, WORDS = 0, 1, 2  # forms: words that begin sentences are plain, or names; or no slots at all


def _hash(words: list[str]) -> np.ndarray:
    out = [found.hash for found in H.words(*H.buffers(pa.array([" ".join(words)])))]
    return np.sort(np.concatenate(out))


_NUMBERS, _UNITS, _OPENERS = _hash(NUMBER_WORDS), _hash(UNITS), _hash(OPENERS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Template(NamedTuple):
    """The tokens of some rows in one form."""

    token: np.ndarray
    value: np.ndarray  # of the words that the token stands for
    first: np.ndarray  # its first word, counted in the group of rows
    doubt: np.ndarray  # whether it holds a word that may or may not be a name
    ptr: np.ndarray  # where each row's tokens begin

    def row(self, k: int) -> Template:
        a, b = self.ptr[k], self.ptr[k + 1]
        return Template(self.token[a:b], self.value[a:b], self.first[a : b + 1] - self.first[a], self.doubt[a:b], np.array([0, b - a]))


def _collapse(found: H.Words, token: np.ndarray, doubt: np.ndarray, joins: np.ndarray) -> Template:
    """Neighbouring words of one slot type, where ``joins`` allows it, as one token."""
    n = len(token)
    slot = (token == NUMBER) | (token == NAME) | (token == UNIT)
    new = np.ones(n, dtype=bool)
    new[1:] = ~(slot[1:] & (token[1:] == token[:-1]) & joins)
    new[found.ptr[:-1][np.diff(found.ptr) > 0]] = True
    first = np.flatnonzero(new)
    place = np.arange(n) - first[np.cumsum(new) - 1]
    value = np.add.reduceat(H.mix64(found.hash + place.astype(H.U64) * H._STEPS[7]), first)
    return Template(token[first], value, np.append(first, n), np.logical_or.reduceat(doubt, first), np.searchsorted(first, found.ptr))


def templates(data: np.ndarray, offsets: np.ndarray, words_too: bool = True) -> Iterator[tuple[int, int, list[Template]]]:
    """(first row, last row, the template in each form) of groups of rows."""
    for found in H.words(data, offsets, H.LOWER, _BREAK):
        n = len(found.hash)
        if not n:
            none = Template(found.hash, found.hash, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool), found.ptr)
            yield found.first, found.last, [none] * (2 + words_too)
            continue
        lo = int(offsets[found.first])
        stops = np.cumsum(_STOP[data[lo : int(offsets[found.last])]], dtype=np.int32)
        begins = np.zeros(n, dtype=bool)  # a sentence, a line or a row
        begins[found.ptr[:-1][np.diff(found.ptr) > 0]] = True
        begins[1:] |= stops[found.start[1:] - lo] > stops[found.end[:-1] - 1 - lo]
        gap = found.start[1:] - found.end[:-1]
        between = data[found.end[:-1]]
        first = data[found.start]
        number = (first >= 48) & (first < 58) | _among(found.hash, _NUMBERS)
        second = data[np.minimum(found.start + 1, found.end - 1)]  # of a word in capitals or of one letter it is a capital
        capital = (first >= 65) & (first < 91) & (second > 90) & ~number & ~_among(found.hash, _OPENERS)
        unit = np.zeros(n, dtype=bool)
        unit[1:] = number[:-1] & (gap == 1) & ((between == 32) | (between == 45)) & _among(found.hash[1:], _UNITS)
        unit[found.ptr[:-1][np.diff(found.ptr) > 0]] = False
        # a point or comma inside a number is no break
        joins = ~begins[1:] | (token_point := number[1:] & number[:-1] & (gap == 1) & (between > 32))
        begins[1:] &= ~token_point
        out = []
        for form in (PLAIN, NAMED):
            token = found.hash.copy()
            token[unit] = UNIT
            token[capital if form == NAMED else capital & ~begins & ~unit] = NAME
            token[number] = NUMBER
            out.append(_collapse(found, token, capital & begins, joins))
        if words_too:
            out.append(Template(found.hash, H.mix64(found.hash), np.arange(n + 1), np.zeros(n, dtype=bool), found.ptr))
        yield found.first, found.last, out


def windows(token: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` tokens, by its first token."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, H.U64)
    h = np.zeros(n, H.U64)
    for k in range(width):
        h = h * H._STEPS[5] + token[k : k + n]
    return H.mix64(h + H.U64(width))


def _slots(token: np.ndarray) -> np.ndarray:
    return (token == NUMBER) | (token == NAME) | (token == UNIT)


class Index:
    """Window hashes in order of the items that are compared in one form, with the item and position of each."""

    def __init__(self, items: dict[int, Template]):
        self.items = items
        self.widths = sorted({min(WINDOW, len(t.token)) for t in items.values()})
        parts = [(h := windows(t.token, min(WINDOW, len(t.token))), np.full(len(h), i), np.arange(len(h))) for i, t in items.items()]
        h, item, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, H.U64), np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order].astype(np.int32), at[order].astype(np.int32)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hash >> H.U64(44)).astype(np.int64)] = True

    def meets(self, token: np.ndarray) -> bool:
        """Whether any window may be an item's: most groups of rows meet nothing."""
        return any(self.seen[(windows(token, w) >> H.U64(44)).astype(np.int64)].any() for w in self.widths)

    def hits(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of each window in common."""
        out = []
        for width in self.widths:
            h = windows(token, width)
            maybe = np.flatnonzero(self.seen[(h >> H.U64(44)).astype(np.int64)])
            left, right = np.searchsorted(self.hash, h[maybe]), np.searchsorted(self.hash, h[maybe], side="right")
            n = right - left
            if n.any():
                which = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append((np.repeat(maybe, n), self.item[which], self.at[which]))
        if not out:
            none = np.zeros(0, int)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


class Benchmark:
    """The items of a block, indexed by the forms in which each is compared."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        by_form: list[dict[int, Template]] = [{}, {}, {}]
        for first, last, forms in templates(*H.buffers(pa.array(texts, pa.large_string()))):
            for i in range(first, last):
                plain, named, words = (f.row(i - first) for f in forms)
                if _telling(plain.token):
                    by_form[PLAIN][i] = plain
                    if _telling(named.token):
                        by_form[NAMED][i] = named
                elif len(words.token) >= SHORTEST:
                    by_form[WORDS][i] = words
        self.forms = [(k, Index(items)) for k, items in enumerate(by_form) if items]


def _telling(token: np.ndarray) -> bool:
    """Whether a template is long enough and has a plain word."""
    return len(token) >= SHORTEST and not _slots(token).all()


def runs(at: np.ndarray, item: np.ndarray, there: np.ndarray, widths: dict[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, start in the item, length) of each run of adjacent windows on one diagonal."""
    order = np.lexsort((at, at - there, item))
    at, item, there = at[order], item[order], there[order]
    new = np.append(True, (item[1:] != item[:-1]) | (at[1:] - there[1:] != at[:-1] - there[:-1]) | (at[1:] > at[:-1] + 1))
    edge = np.flatnonzero(np.append(new, True))
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(item[a]), int(at[a]), int(there[a]), int(at[b - 1] - at[a]) + widths[int(item[a])]


Found = tuple[int, int, int, int, int, int]


def judged(mine: Template, index: Index, least: int) -> list[Found]:
    """What one document holds of each item: item, first word, end word, tokens, slots, slots that changed.

    An item counts by the longest of its long runs that agrees, or by shorter runs that cover half of it.
    """
    at, item, there = index.hits(mine.token)
    if not len(at):
        return []
    widths = {int(i): min(WINDOW, len(index.items[int(i)].token)) for i in np.unique(item)}
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for i, a, b, n in runs(at, item, there, widths):
        by_item.setdefault(i, []).append((n, a, b))
    out = []
    for i, found in by_item.items():
        theirs = index.items[i]
        size = len(theirs.token)
        found.sort(key=lambda r: (-r[0], r[1], r[2]))
        tried = [(np.arange(b, b + n), np.arange(a, a + n)) for n, a, b in found if n >= min(least, size)]
        covered, document = np.zeros(size, dtype=bool), np.full(size, -1)  # of the item by its pieces, and where its tokens stand
        for n, a, b in found[len(tried) :]:  # the longest piece has the say where pieces overlap
            free = np.flatnonzero(~covered[b : b + n]) + b
            covered[free], document[free] = True, a + free - b
        if covered.sum() >= max(least, size / 2):
            tried.append((np.flatnonzero(covered), document[covered]))
        for there_, here in tried:
            kinds, was, is_ = theirs.token[there_], theirs.value[there_], mine.value[here]
            if size < WINDOW and (was != is_)[theirs.doubt[there_] | mine.doubt[here]].any():
                continue
            if _agrees(was, is_, kinds):
                slot = _slots(kinds)
                out.append((i, int(mine.first[here.min()]), int(mine.first[here.max() + 1]), len(here), int(slot.sum()), int((was[slot] != is_[slot]).sum())))
                break
    return out


def _agrees(theirs: np.ndarray, mine: np.ndarray, kinds: np.ndarray) -> bool:
    """The very words; or enough plain ones, and values that go together one to one."""
    if (theirs == mine).all():
        return True
    slot = _slots(kinds)
    if len(kinds) - slot.sum() < PLAIN_SHARE * len(kinds):
        return False
    pairs = set(zip(theirs[slot].tolist(), mine[slot].tolist()))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


RESULT = "item_id bigint, token_start bigint, token_end bigint, n_tokens bigint, n_slots bigint, changed bigint"


def _held(texts: pa.Array, bench: Benchmark, least: int) -> Iterator[tuple[int, Found]]:
    """(row, what it holds) of each row and item: in the first form that finds it."""
    words_too = any(form == WORDS for form, _ in bench.forms)
    for first, last, templated in templates(*H.buffers(texts), words_too):
        some = [(index, templated[form]) for form, index in bench.forms if index.meets(templated[form].token)]
        if not some:
            continue
        for k in range(last - first):
            by_item: dict[int, Found] = {}
            for index, mine in some:
                for got in judged(mine.row(k), index, least):
                    by_item.setdefault(got[0], got)
            yield from ((first + k, got) for got in by_item.values())


def _matcher(bench: Benchmark, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_held(batch.column("text"), bench, least))
            columns = list(zip(*((bench.ids[got[0]], *got[1:]) for _, got in found))) if found else [[]] * 6
            names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([k for k, _ in found], pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return match


def _blocks(benchmark: DataFrame, max_broadcast: int) -> Iterator[Benchmark]:
    """The whole benchmark in blocks of about ``2 * max_broadcast`` bytes of text, or of one item, one after another."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n = min(size["n"], -(-size["bytes"] // max(1, 2 * max_broadcast)))  # a window has a word of its own, so two bytes at least
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Benchmark([r.item_id for r in rows], [r.text for r in rows])


def _without(docs: DataFrame, bench: Benchmark, least: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, dtype=bool)
            stays[[k for k, _ in _held(batch.column("text"), bench, least)]] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)


ROW = "_strataline_text"


def _digest() -> Column:
    """Of a text: rows with equal texts are judged alike."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark."""
    blocks = _blocks(benchmark, max_broadcast)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return _without(docs, first, least)
    texts = docs.select("text").where("text is not null")

    def held(bench: Benchmark) -> DataFrame:
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = sorted({k for k, _ in _held(batch.column("text"), bench, least)})
                yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(rows, pa.int64()))], names=["text"])

        return texts.mapInArrow(digests, "text string").select(_digest().alias(ROW))

    gone = materialize(reduce(DataFrame.union, map(held, chain((first, second), blocks))).distinct(), "benchmark")
    return only(docs.withColumn(ROW, _digest()), gone, ROW, "left_anti").select(docs.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents that hold items of the benchmark, one row per document and item."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    found = [docs.mapInArrow(_matcher(bench, least), f"doc_id bigint, {RESULT}") for bench in _blocks(benchmark, max_broadcast)]
    if not found:
        return docs.limit(0).select("doc_id", *(F.lit(None).cast("bigint").alias(x.split()[0]) for x in RESULT.split(", ")))
    return reduce(DataFrame.union, found).distinct()
