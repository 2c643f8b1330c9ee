"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct part of a text encoded once per worker.

The library's own splitter never joins a character that isn't white space with white space that follows it, so a text
may be cut before any such white space and its parts encoded apart: the ids are those of the whole text. In an even
text (every white space is one space or line feed between words) the parts are the words with the separator before
them; parts that a worker has not met lately are encoded by one call of the library over their joint text, in which
each part's ids begin at the one token that begins with its separator. Other texts are cut by a pattern.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexatlas.llm.part_codes import PartCodes, ranges
from lexatlas.llm.textkernel import U, Words, mix, slices, text_buffers

#: Unicode White_Space, which is what the splitter's \\s means. Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"
_PARTS = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_RARE_WHITE = re.compile("[\t\x0b-\r\x85\xa0  -     　]")
#: First bytes of white space other than space and line feed.
_RARE_LEAD = np.zeros(256, bool)
_RARE_LEAD[[0x09, 0x0B, 0x0C, 0x0D, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_APART = np.zeros(256, bool)
_APART[[0x20, 0x0A]] = True
SLICE_BYTES, SLICE_DOCS = 4 << 20, 1 << 14
#: Bytes of parts encoded by one call.
JOINED_BYTES = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def uneven(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: whether it has white space that is no single space or line feed between words."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    if not len(data):
        return out
    of = lambda places: np.searchsorted(offsets, places, "right") - 1
    white = _APART[data]
    full = np.flatnonzero(np.diff(offsets) > 0)
    out[full] = white[offsets[full]] | white[offsets[full + 1] - 1]
    out[of(np.flatnonzero(white[1:] & white[:-1]))] = True
    for d in np.unique(of(np.flatnonzero(_RARE_LEAD[data]))).tolist():
        out[d] = out[d] or _RARE_WHITE.search(data[offsets[d] : offsets[d + 1]].tobytes().decode()) is not None
    return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self._whole = lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        self.vocabulary = tokenizer.get_vocab_size()
        #: separator -> which ids begin with it
        self._begins = {}
        for separator in (" ", "\n"):
            letter = tokenizer.id_to_token(self._whole([separator])[0][0])
            self._begins[separator] = np.array([(tokenizer.id_to_token(i) or "").startswith(letter) for i in range(self.vocabulary)])
        self._feed = len(self._whole(["\n"])[0])
        self._codes = PartCodes(self._encode_parts)

    def _joined(self, separator: str, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of n parts, each a separator and a word, put together."""
        text = raw.decode()
        ids = np.array(self._whole([text])[0], np.uint32)
        at = np.flatnonzero(self._begins[separator][ids])
        if len(at) == n and at[0] == 0:
            return np.diff(np.append(at, len(ids))), ids
        apart = self._whole([separator + word for word in text.split(separator)[1:]])
        return np.array([len(x) for x in apart], np.int64), np.array([i for x in apart for i in x], np.uint32)

    def _encode_parts(self, which: np.ndarray, words: Words, after_feed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, pieces, order = [], [], []
        for separator, chosen in ((" ", which[~after_feed[which]]), ("\n", which[after_feed[which]])):
            size = words.end[chosen] - words.start[chosen] + 1
            room = np.cumsum(size)
            for part in np.split(np.arange(len(chosen)), np.unique(np.searchsorted(room, np.arange(JOINED_BYTES, room[-1] if len(room) else 0, JOINED_BYTES)))):
                if len(part):
                    raw = words.data[ranges(words.start[chosen[part]] - 1, size[part])]  # the byte before a text's first word may be another's
                    raw[room[part] - room[part[0]] + size[part[0]] - size[part]] = ord(separator)
                    n, ids = self._joined(separator, raw.tobytes(), len(part))
                    counts.append(n)
                    pieces.append(ids)
            order.append(np.flatnonzero(after_feed[which] == (separator == "\n")))
        n, ids, back = np.concatenate(counts), np.concatenate(pieces), np.argsort(np.concatenate(order))
        return n[back], ids[ranges((np.cumsum(n) - n)[back], n[back])]

    def _encode_even(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids). A text's first word is encoded after a line feed, whose ids then go."""
        words = Words(data, offsets, lower=False, space=_APART)
        after_feed = data[np.maximum(words.start - 1, 0)] == 0x0A
        heads = words.first[:-1][words.count > 0]
        after_feed[heads] = True
        counts, ids = self._codes.gather(mix(words.hash ^ np.where(after_feed, U(0x9FB21C651E98DF25), U(0))), words, after_feed)
        begin = np.cumsum(counts) - counts
        if len(heads):
            keep = np.ones(len(ids), bool)
            for k in range(self._feed):
                keep[begin[heads] + k] = False
            counts[heads] -= self._feed
            ids = ids[keep]
        total = np.concatenate([[0], np.cumsum(counts)])
        return total[words.first[1:]] - total[words.first[:-1]], ids

    def encode_parts_of(self, text: str) -> np.ndarray:
        """The ids of any text, cut before white space that follows another character."""
        parts = _PARTS.split(text)
        distinct = dict.fromkeys(parts)
        have = dict(zip(distinct, (np.array(x, "<u4") for x in self._whole(list(distinct)))))
        return np.concatenate([have[p] for p in parts])

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of each text of a run of rows, all their ids) of a string column; nulls are empty."""
        data, off = text_buffers(column)
        for a, b in slices(off, SLICE_BYTES, SLICE_DOCS):
            run, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
            odd = np.flatnonzero(uneven(run, at))
            if not len(odd):
                yield a, *self._encode_even(run, at)
                continue
            size = np.diff(at)
            size[odd] = 0
            even = np.ones(len(run), bool)
            for d in odd:
                even[at[d] : at[d + 1]] = False
            counts, ids = self._encode_even(run[even], np.concatenate([[0], np.cumsum(size)]))
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for d in odd.tolist():
                pieces[d] = self.encode_parts_of(run[at[d] : at[d + 1]].tobytes().decode())
            yield a, np.array([len(x) for x in pieces], np.int64), np.concatenate(pieces)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        return b"".join(ids.astype("<u4").tobytes() for _, _, ids in self.encode_column(pa.array([text], pa.string())))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    found = _encoders.get(path)
    if found is None:
        found = _encoders[path] = WordEncoder(path)
    return found
