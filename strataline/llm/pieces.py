"""Sampled SentencePiece segmentation, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a position.
Forward filtering sums the weights of all paths to each position; backward sampling then
draws edges from the end, each with the share of its paths, so a whole segmentation is
drawn from the exact distribution over all of them. The draws are keyed by the row key,
the unit's number in the row and the step, so a row always gets the same segmentation.

A piece never holds a space after another character, so paths pass through every place
before a space that follows something else: such units are filtered once per distinct
unit and batch, all positions of all units at a time. Characters without a piece become
byte pieces. A space stands for the model's space mark, one is put before the text, and a
literal space mark in a text goes to byte pieces; decoding gives back the very text.

The weight of a piece is (2 + its rank) ** -theta: the model's ranks, not trained.

Defined results: a null text has null tokens, an empty text none. Rows with a null key
share the key 0. Empty tables give empty tables; repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _hashing as H

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.0
#: Bytes of text in a lattice, which takes up to about 100 bytes for each of them.
LATTICE = 1 << 18


class Vocabulary(NamedTuple):
    pieces: list[bytes]  # by id; spaces for space marks
    hash: np.ndarray  # sorted, of the pieces that the lattice uses
    id: np.ndarray
    weight: np.ndarray  # log weight by id
    byte_id: np.ndarray  # of each byte's piece
    longest: int
    flat: np.ndarray  # all pieces' bytes, for decoding
    at: np.ndarray
    size: np.ndarray
    slot: np.ndarray  # by the first 20 bits of a hash, a piece's place in ``hash`` or -1
    crowded: np.ndarray
    ascii: np.ndarray  # which single bytes are pieces


def load(path: str = DEFAULT_MODEL, theta: float = THETA) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, used, byte_id, weight = [], [], np.full(256, -1), np.zeros(n)
    for i in range(n):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(text[1:-1], 16)] = i
            pieces.append(bytes([int(text[1:-1], 16)]))
            continue
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        raw = b"" if special else text.replace("▁", " ").encode()
        pieces.append(raw)
        weight[i] = -theta * np.log(2 - min(0.0, model.get_score(i)))
        if raw and not special and b" " not in raw.lstrip(b" "):  # one that crosses units is left out
            used.append(i)
    if max(map(len, pieces)) > 63:
        raise ValueError("pieces of more than 63 bytes are not provided for")
    if (byte_id < 0).any():
        raise ValueError("the model has no piece for some byte, so decoding could not be lossless")
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    at = np.cumsum(size) - size
    up = H.Prefix(flat, H.EXACT)
    ids = np.array(used)
    hashed = up.ranges(at[ids], at[ids] + size[ids])
    order = np.argsort(hashed)
    top = (hashed[order] >> H.U64(44)).astype(np.int64)
    slot = np.full(1 << 20, -1, dtype=np.int32)
    slot[top] = np.arange(len(top))
    crowded = np.bincount(top, minlength=1 << 20)[top] > 1
    single = np.zeros(256, dtype=bool)
    single[[pieces[i][0] for i in used if len(pieces[i]) == 1]] = True
    return Vocabulary(pieces, hashed[order], ids[order].astype(np.int32), weight, byte_id, int(size[ids].max()), flat, at, size, slot, crowded, single)


def find(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are pieces, and the ids of those."""
    slot = v.slot[(h >> H.U64(44)).astype(np.int64)]
    maybe = np.flatnonzero(slot >= 0)
    at, h = slot[maybe], h[maybe]
    hit = v.hash[at] == h
    other = np.flatnonzero(~hit & v.crowded[at])  # pieces that share a slot
    at[other] = np.minimum(np.searchsorted(v.hash, h[other]), len(v.hash) - 1)
    hit[other] = v.hash[at[other]] == h[other]
    return maybe[hit], v.id[at[hit]]


def _units(v: Vocabulary, data: np.ndarray, row_starts: np.ndarray, prefix: H.Prefix) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and which of them are single characters without a piece."""
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[row_starts] = begins[n] = True
    space = data == 32
    begins[1:n] |= space[1:] & ~space[:-1]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, n))
    covered = v.ascii[data[lead]] & (size == 1)
    wide = np.flatnonzero(size > 1)
    hit, _ = find(v, prefix.ranges(lead[wide], lead[wide] + size[wide]))
    covered[wide[hit]] = True
    bare = np.flatnonzero(~covered)
    begins[lead[bare]] = True
    begins[lead[bare] + size[bare]] = True
    starts = np.flatnonzero(begins[:n])
    alone = np.zeros(n, dtype=bool)
    alone[lead[bare]] = True
    return starts, alone[starts]


class Lattice(NamedTuple):
    """Edges sorted by the node they lead to. Nodes are numbered by position in the unit first, then by unit."""

    share: np.ndarray  # of each edge among those into its node
    source: np.ndarray
    piece: np.ndarray
    first: np.ndarray  # the first edge into each node
    level: np.ndarray  # the first node of each position


def lattice(v: Vocabulary, data: np.ndarray, size: np.ndarray, bare: np.ndarray) -> Lattice:
    """Forward filtering over units that lie end to end in ``data``, the longest first."""
    n_units, to = len(size), np.cumsum(size)
    # positions and nodes are below 2**31, in half the memory of longs
    unit = np.repeat(np.arange(n_units, dtype=np.int32), size)
    inside = np.arange(len(data), dtype=np.int32) - (to - size).astype(np.int32)[unit]
    # units of at least k bytes are the first alive[k]
    alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")
    level = np.append(0, np.cumsum(alive)).astype(np.int32)
    prefix = H.Prefix(data, H.EXACT)
    left = size.astype(np.int32)[unit] - inside
    open_ = ~bare[unit]
    starts, lengths, ids = [], [], []
    at = np.flatnonzero(open_).astype(np.int32)
    for n in range(1, min(v.longest, int(size[0])) + 1):
        at = at[left[at] >= n]
        if not len(at):
            break
        hit, got = find(v, prefix.ranges(at, at + n))
        starts.append(at[hit])
        lengths.append(np.full(len(hit), n, dtype=np.int32))
        ids.append(got)
    forced = np.flatnonzero(~open_).astype(np.int32)
    start = np.concatenate([*starts, forced])
    length = np.concatenate([*lengths, np.ones(len(forced), np.int32)])
    piece = np.concatenate([*ids, v.byte_id[data[forced]].astype(np.int32)])
    del starts, lengths, ids, left, prefix
    owner, at = unit[start], inside[start]
    sink = level[at + length] + owner
    order = np.argsort(sink.astype(np.int64) * 64 + length)  # one order of a node's edges, whatever else is in the batch
    sink, piece = sink[order], piece[order]
    source = (level[at] + owner)[order]
    del owner, at, start, length, order
    weight = v.weight[piece]
    first = np.searchsorted(sink, np.arange(level[-1] + 1))
    alpha = np.full(level[-1], -np.inf)
    alpha[: alive[0]] = 0
    share = np.empty(len(source))
    for k in range(1, len(alive)):  # position by position, all units at once
        a, b = first[level[k]], first[level[k + 1]]
        if a == b:
            continue
        w = alpha[source[a:b]] + weight[a:b]
        mine = sink[a:b]
        edge = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        reps = np.diff(np.append(edge, b - a))
        most = np.maximum.reduceat(w, edge)
        most[np.isneginf(most)] = 0
        p = np.exp(w - np.repeat(most, reps))
        total = np.add.reduceat(p, edge)
        with np.errstate(divide="ignore"):
            alpha[mine[edge]] = most + np.log(total)
        share[a:b] = p / np.repeat(np.maximum(total, 1e-300), reps)
        share[a + edge + reps - 1] = 2.0  # whatever is drawn, the last edge takes it
    return Lattice(share, source, piece, first, level)


def _draw(lat: Lattice, unit: np.ndarray, size: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of all units at once: their pieces in text order, and how many each has."""
    who, steps = [], []
    active, node, n = np.arange(len(unit), dtype=np.int32), lat.level[size] + unit.astype(np.int32), np.zeros(len(unit), dtype=np.int64)
    bottom = lat.level[1]  # nodes before the first byte
    step = 0
    while len(active):
        salt = H.stream64(1, 1000 + step)
        u = (H.mix64(seed[active] + salt) >> H.U64(11)).astype(np.float64) * 2.0**-53
        edge = lat.first[node]
        behind, over = np.arange(len(edge)), u
        while True:
            p = lat.share[edge[behind]]
            past = over >= p
            behind, over = behind[past], over[past] - p[past]
            if not len(behind):
                break
            edge[behind] += 1
        who.append(active)
        steps.append(lat.piece[edge])
        n[active] = step + 1
        node = lat.source[edge]
        on = node >= bottom
        active, node = active[on], node[on]
        step += 1
    base = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.int32)
    for k, (w, p) in enumerate(zip(who, steps)):
        out[base[w] + n[w] - 1 - k] = p
    return out, n


def _cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long row, cut before a space that follows something else."""
    most = min(LATTICE, H.PIECE)
    while hi - lo > 2 * most:
        cut, a = hi, lo + most
        while a < hi:
            b = min(hi, a + most)
            here = np.flatnonzero((data[a:b] == 32) & (data[a - 1 : b - 1] != 32))
            if len(here):
                cut = a + int(here[0])
                break
            a = b
        if cut == hi:
            break
        yield lo, cut
        lo = cut
    yield lo, hi


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, tokens, offsets of each row's tokens) in groups of rows."""
    for first, last in H.groups(offsets, min(LATTICE, H.PIECE)):
        parts: list[np.ndarray] = []
        counts = np.zeros(last - first, dtype=np.int64)
        done = 0  # units of a long row before the piece at hand
        for a, b in _cuts(data, int(offsets[first]), int(offsets[last])) if offsets[last] > offsets[first] else ():
            whole = a == offsets[first]
            rows = np.flatnonzero(np.diff(offsets[first : last + 1])) if last - first > 1 else np.array([0])
            begin = np.maximum(offsets[first:last][rows], a) - a
            if whole:
                text = np.insert(data[a:b], begin, 32)
                begin = begin + np.arange(len(begin))
            else:
                text = data[a:b]
            prefix = H.Prefix(text, H.EXACT)
            start, bare = _units(v, text, begin, prefix)
            end = np.append(start[1:], len(text))
            hashed = prefix.ranges(start, end)
            order = np.argsort(hashed)
            new = np.append(True, hashed[order[1:]] != hashed[order[:-1]])
            where = order[new]
            inverse = np.empty(len(order), dtype=np.int32)
            inverse[order] = np.cumsum(new) - 1
            # distinct units, the longest first
            long = np.argsort(start[where] - end[where], kind="stable")
            place = np.empty(len(long), dtype=np.int64)
            place[long] = np.arange(len(long))
            where, inverse = where[long], place[inverse]
            size = end[where] - start[where]
            to = np.cumsum(size)
            distinct = text[np.repeat(start[where] - (to - size), size) + np.arange(int(to[-1]))]
            lat = lattice(v, distinct, size, bare[where])
            row = np.searchsorted(begin, start, side="right") - 1
            nth = np.arange(len(start)) - np.searchsorted(start, begin)[row] + done
            seed = H.mix64(keys[first + rows[row]] + nth.astype(H.U64) * H.U64(0xE7037ED1A0B428DB))
            tokens, n = _draw(lat, inverse, size[inverse], seed)
            parts.append(tokens)
            counts += np.bincount(rows[row], weights=n, minlength=last - first).astype(np.int64)
            done += len(start)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        yield first, last, tokens, np.append(0, np.cumsum(counts))


def decode(v: Vocabulary, tokens: np.ndarray) -> bytes:
    """The text of one row's tokens, without the space before it."""
    size = v.size[tokens]
    to = np.cumsum(size)
    if not len(to):
        return b""
    return v.flat[np.repeat(v.at[tokens] - (to - size), size) + np.arange(int(to[-1]))][1:].tobytes()


def row_keys(column: pa.Array, seed: int) -> np.ndarray:
    ids = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(H.U64)
    return H.mix64(ids + H.U64(0x8EBC6AF09C88C6E3) + np.full(1, seed, H.U64))


def tokenize(docs: DataFrame, model: str = DEFAULT_MODEL, theta: float = THETA, seed: int = 0) -> DataFrame:
    """doc_id, its sampled tokens (array<int>), and whether decoding them gives the very text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, theta))  # one vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.buffers(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for first, last, tokens, at in encode(shared.value, data, offsets, row_keys(batch.column("doc_id"), seed)):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null[first:last], False)), pa.array(tokens, pa.int32()))
                same = [None if null[k] else decode(shared.value, tokens[at[k - first] : at[k - first + 1]]) == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists, pa.array(same, pa.bool_())], names=["doc_id", "tokens", "lossless"])
            H.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, tokens array<int>, lossless boolean")


def detokenize(tokens: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and the text of its tokens."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else decode(shared.value, np.asarray(t, dtype=np.int64)).decode("utf-8") for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "tokens").mapInArrow(join, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model: str = DEFAULT_MODEL, theta: float = THETA, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, digest of the ids (32 bits each, low byte first), digest of the decoded text, and whether it is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, theta))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.buffers(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for first, last, tokens, at in encode(shared.value, data, offsets, row_keys(batch.column("doc_id"), seed)):
                n, ids, texts, same = [], [], [], []
                for k in range(first, last):
                    mine = tokens[at[k - first] : at[k - first + 1]]
                    if null[k]:
                        n, ids, texts, same = n + [None], ids + [None], texts + [None], same + [None]
                        continue
                    text = decode(shared.value, mine)
                    n.append(len(mine))
                    ids.append(hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(text).hexdigest())
                    same.append(text == data[offsets[k] : offsets[k + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "text_sha256", "lossless"])
            H.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, text_sha256 string, lossless boolean")
