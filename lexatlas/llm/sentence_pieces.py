"""SentencePiece encoding and decoding by a streaming Viterbi search over piece boundaries.

The lattice has a node for each character boundary and an edge for each piece. For a BPE model the best path to a node
is the encoding of the text before it; it is known by its last piece, and a piece may follow another exactly if merging
their joint text gives the two again. So each node keeps one backpointer, the piece that fits the path at its start.
Only the last max-piece-length nodes can still be extended; ids are committed as soon as all backpointer paths from
these nodes go through one boundary, and the window before it is dropped. A text is thus never held as a whole lattice.
Characters without a piece become their bytes.

Where no piece spans a word boundary (true of models trained by splitting at white space), all paths converge there, so
every word is a window of its own. The windows of a run of texts are lanes of one search: step p extends all lanes to
their p-th boundary, edge by edge of a sorted array, and a lane commits at its end. Words longer than LANE characters,
and whole texts of models whose pieces span words, go through stream(), which commits at each convergence inside.

Results: rows without doc_id are dropped; a null or empty text has no ids; each of several rows with one doc_id has its
own result. Decoding gives back the text, but for U+2581, which the model itself uses for a space and reads as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.part_codes import PartCodes, ranges
from lexatlas.llm.textkernel import U, Words, mix, of_batches, slices, text_buffers

SPACE_PIECE = "▁"
#: Pairs of pieces of which a worker remembers whether one may follow the other: strings of stream(), and slots of a fixed table.
MEMO_PAIRS, PAIR_SLOTS = 200_000, 1 << 21
#: Characters of the longest lane; bytes and texts of a run.
LANE, RUN_BYTES, RUN_TEXTS = 64, 4 << 20, 1 << 14
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -model.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        tails: dict[str, set[int]] = {}
        for p in self.id_of:
            if len(p) > 1:
                tails.setdefault(p[-2:], {1}).add(len(p))
        #: last two characters -> lengths of the pieces that end so, longest first, and 1
        self._tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.words_apart = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in self.id_of)
        self._follow: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._lanes_ready, self._is_byte = False, None

    def _prepare_lanes(self) -> None:
        """The automaton of usable pieces of two or more characters, and tables by id and code point."""
        import ahocorasick

        self._lanes_ready = True
        self._pieces_of = ahocorasick.Automaton()
        letters = {c for p in self.id_of for c in p}
        self._apart = next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in letters)
        self._bigrams = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        for p, i in self.id_of.items():
            if len(p) > 1 and self.merged(p) == [p]:
                self._pieces_of.add_word(p, i)
        self._pieces_of.make_automaton()
        n = len(self.pieces)
        #: characters of a piece; ids from n on stand for code points without a piece
        self._size = np.array([len(p) for p in self.pieces], np.int64)
        self._first_byte = np.array([self.byte_ids.get(b, 0) for b in range(256)], np.int64)
        self._pairs = np.zeros(PAIR_SLOTS, np.uint64)
        self._n = n
        self._codes = PartCodes(self._encode_words)

    def _char_ids(self, chars: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(chars, return_inverse=True)
        return np.array([self.id_of.get(chr(c), self._n + c) if not 0xD800 <= c < 0xE000 else self._n + c for c in distinct.tolist()], np.int64)[which]

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids: whether merging their joint text gives the two again."""
        out = np.ones(len(left), bool)
        at = np.flatnonzero((left < self._n) & (right < self._n))
        key = (left[at] * self._n + right[at] + 1).astype(np.uint64)
        slot = (mix(key) >> U(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        held = self._pairs[slot]
        out[at] = (held & U(1)).astype(bool)
        unknown = np.flatnonzero(held >> U(1) != key)
        if len(unknown):
            distinct, first, which = np.unique(key[unknown], return_index=True, return_inverse=True)
            of = unknown[first]
            found = np.array([self._pair(self.pieces[x], self.pieces[y]) for x, y in zip(left[at[of]].tolist(), right[at[of]].tolist())], bool)
            self._pairs[slot[of]] = distinct << U(1) | found.astype(np.uint64)
            out[at[unknown]] = found[which]
        return out

    def _pair(self, left: str, right: str) -> bool:
        return left[-1] + right[0] not in self._bigrams or self.merged(left + right) == [left, right]

    def lanes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of normalised words of at most LANE characters: one search, a lane a word."""
        n, size = self._n, np.fromiter(map(len, words), np.int64, len(words))
        text = self._apart.join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(size + 1) - size - 1
        single = np.ones(len(chars), bool)
        single[begin[1:] - 1] = False
        found = np.fromiter(chain.from_iterable(self._pieces_of.iter(text)), np.int64).reshape(-1, 2)
        at = np.flatnonzero(single)
        end = np.concatenate([at + 1, found[:, 0] + 1])
        piece = np.concatenate([self._char_ids(chars[at]), found[:, 1]])
        start = end - np.where(piece < n, self._size[np.minimum(piece, n - 1)], 1)
        step = end - begin[np.searchsorted(begin, end - 1, "right") - 1]
        order = np.argsort(step.astype(np.uint8), kind="stable")
        end, start, piece = end[order], start[order], piece[order]
        last = np.full(len(chars) + 1, -1, np.int64)
        bounds = np.searchsorted(step[order], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            left, right = last[start[a:b]], piece[a:b]
            fits = left < 0
            later = np.flatnonzero(~fits)
            fits[later] = self._may_follow(left[later], right[later])
            last[end[a:b][fits]] = right[fits]
        # all paths of a lane meet at its end: commit along the backpointers
        cur, lane, hits = begin + size, np.arange(len(words)), []
        while len(cur):
            got = last[cur]
            hits.append((cur, lane, got))
            cur = cur - np.where(got < n, self._size[np.minimum(got, n - 1)], 1)
            open_ = cur > begin[lane]
            cur, lane = cur[open_], lane[open_]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        place, lane, ids = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(place)
        lane, ids = lane[order], ids[order]
        bare = np.flatnonzero(ids >= n)
        if len(bare):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[bare] - n).tolist()]
            width = np.ones(len(ids), np.int64)
            width[bare] = [len(r) for r in raw]
            to = np.cumsum(width) - width
            lane, ids = np.repeat(lane, width), np.repeat(ids, width)
            ids[ranges(to[bare], width[bare])] = self._first_byte[np.frombuffer(b"".join(raw), np.uint8)]
        return np.bincount(lane, minlength=len(words)), ids.astype(np.uint32)

    def _all_lanes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if max(map(len, words), default=0) <= LANE:
            return self.lanes(words)
        short = [w for w in words if len(w) <= LANE]
        counts, ids = self.lanes(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        pieces, got = iter(np.split(ids, np.cumsum(counts)[:-1])), []
        for w in words:
            got.append(next(pieces) if len(w) <= LANE else np.array(self.ids(self.stream(w)), np.uint32))
        return np.array([len(x) for x in got], np.int64), np.concatenate(got)

    def _encode_words(self, which: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        size = words.end[which] - words.start[which] + 1
        raw = words.data[ranges(words.start[which] - 1, size)]
        raw[np.cumsum(size) - size] = 0x20
        return self._all_lanes([SPACE_PIECE + w for w in raw.tobytes().decode().split(" ")[1:]])

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of each text of a run of rows, all their ids) of a string column; nulls are empty."""
        if not self._lanes_ready:
            self._prepare_lanes()
        data, off = text_buffers(column)
        for a, b in slices(off, RUN_BYTES, RUN_TEXTS):
            run, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
            odd = np.flatnonzero(self._odd(run, at))
            size = np.diff(at)
            if len(odd):
                size[odd] = 0
                even = np.ones(len(run), bool)
                for d in odd:
                    even[at[d] : at[d + 1]] = False
                words = Words(run[even], np.concatenate([[0], np.cumsum(size)]), lower=False, space=_BLANK)
            else:
                words = Words(run, at, lower=False, space=_BLANK)
            counts, ids = self._codes.gather(words.hash, words)
            total = np.concatenate([[0], np.cumsum(counts)])
            counts = total[words.first[1:]] - total[words.first[:-1]]
            if len(odd):
                pieces = np.split(ids, np.cumsum(counts)[:-1])
                for d in odd.tolist():
                    pieces[d] = np.frombuffer(self.encode(run[at[d] : at[d + 1]].tobytes().decode()), "<i4").astype(np.uint32)
                counts, ids = np.array([len(x) for x in pieces], np.int64), np.concatenate(pieces)
            yield a, counts, ids

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: whether it has spaces at its ends or beside each other, or the space mark itself; all, if pieces span words."""
        out = np.zeros(len(offsets) - 1, bool)
        if not self.words_apart:
            return ~out
        if not len(data):
            return out
        blank = data == 0x20
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = blank[offsets[full]] | blank[offsets[full + 1] - 1]
        mark = np.flatnonzero(data[2:] == 0x81)
        mark = mark[(data[mark] == 0xE2) & (data[mark + 1] == 0x96)]
        out[np.searchsorted(offsets, np.concatenate([np.flatnonzero(blank[1:] & blank[:-1]), mark]), "right") - 1] = True
        return out

    def merged(self, text: str) -> list[str]:
        """BPE by definition: merge the adjacent pair of best rank, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], np.inf), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.merged(piece) == [piece]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._follow.get(key)
        if known is None:
            if len(self._follow) > MEMO_PAIRS:
                self._follow.clear()
            known = self._follow[key] = self.merged(left + right) == [left, right]
        return known

    def stream(self, text: str):
        """Yield the pieces of a normalised text in order, as they are committed."""
        last: dict[int, str] = {}  # boundary -> last piece of the best path to it, of those in the window
        done, tails, single, whole, follow = 0, self._tails, (1,), self._whole, self._follow
        for end in range(1, len(text) + 1):
            for size in tails.get(text[end - 2 : end] if end > 1 else "", single):
                start = end - size
                if start < done:
                    continue
                piece = text[start:end]
                if size > 1:
                    usable = whole.get(piece)
                    if usable is None:
                        usable = piece in self.id_of and self.whole(piece)
                        if len(whole) > MEMO_PAIRS:
                            whole.clear()
                        whole[piece] = usable
                    if not usable:
                        continue
                left = last.get(start)
                if left is None:
                    if start:
                        continue
                else:
                    fits = follow.get((left, piece))
                    if not (self.may_follow(left, piece) if fits is None else fits):
                        continue
                last[end] = piece
                break
            if end - done >= 2 * self.longest or end == len(text):
                common = self._common(last, done, end, len(text))
                if common > done:
                    path, at = [], common
                    while at > done:
                        path.append(last[at])
                        at -= len(last[at])
                    yield from reversed(path)
                    kept = last[common]
                    last = {k: v for k, v in last.items() if k > common}
                    done = common
                    # the piece before the window still limits what may follow it
                    last[done] = kept

    def _common(self, last: dict[int, str], done: int, end: int, length: int) -> int:
        """The last boundary that every path from a node still in reach goes through."""
        if end == length:
            return end
        heads = {k for k in last if k > max(done, end - self.longest)}
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            heads.add(far - len(last[far]))
        return heads.pop() if heads else done

    def ids(self, pieces) -> list[int]:
        out = []
        for p in pieces:
            i = self.id_of.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian signed 32-bit."""
        if not text:
            return b""
        if not self._lanes_ready:
            self._prepare_lanes()
        if not self.words_apart:
            return np.array(self.ids(self.stream(SPACE_PIECE + text.replace(" ", SPACE_PIECE))), "<i4").tobytes()
        words = words_of(text)
        distinct = list(dict.fromkeys(words))
        counts, ids = self._all_lanes(distinct)
        raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        have = {w: raw[x:y] for w, x, y in zip(distinct, [0, *ends], ends)}
        return b"".join(map(have.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        if self._is_byte is None:
            self._is_byte = np.zeros(len(self.pieces), bool)
            self._is_byte[list(self.byte_of)] = True
        if not self._is_byte[ids].any():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
            return (text[1:] if text.startswith(SPACE_PIECE) else text).replace(SPACE_PIECE, " ")
        out, run = [], bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(SPACE_PIECE) else text).replace(SPACE_PIECE, " ")


def words_of(text: str) -> list[str]:
    """The normalised text cut before each space mark that follows another character."""
    words = text.split(" ") if SPACE_PIECE not in text else text.replace(SPACE_PIECE, " ").split(" ")
    if "" not in words:
        return [SPACE_PIECE + w for w in words]
    out, marks = [], 0
    for w in words:
        marks += 1
        if w:
            out.append(SPACE_PIECE * marks + w)
            marks = 0
    return out + [SPACE_PIECE * marks] * (marks > 0)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    found = _models.get(path)
    if found is None:
        found = _models[path] = PieceModel(path)
    return found


def id_lists(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for first, counts, ids in model(path).encode_column(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(counts)], id_lists(counts, ids)], names=["doc_id", "ids"])

    return runtime.id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: empty)."""
    path = path or default_path()

    def run(batches):
        decode = model(path).decode
        for batch in batches:
            texts = [decode(np.array(ids.as_py() or [], np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids and same (decoding gives the text back, with space marks read as spaces)."""
    path = path or default_path()

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for first, counts, ids in pieces.encode_column(batch.column(1)):
                texts = batch.column(1)[first : first + len(counts)].to_pylist()
                ends = np.cumsum(counts)
                same = [pieces.decode(ids[x:y]) == t.replace(SPACE_PIECE, " ") for t, x, y in zip(texts, (ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(counts)], id_lists(counts, ids), pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "same"])

    return runtime.id_text(docs).mapInArrow(of_batches(run), "doc_id long, ids array<int>, n_ids long, same boolean")


def op3(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text: see round_trip."""
    return round_trip(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
