"""Encoding whole texts with public tokenizer files, by chunks that can be encoded apart.

Both vocabularies split a text before merging, and neither rule looks across a single space that stands
between two characters that aren't white space. So texts are cut there by Arrow, each distinct chunk of a slice
of texts is looked up in a bounded table or encoded once, and the ids are gathered by numpy. A new chunk that is
letters and the ASCII punctuation after them is put together from the two, since neither rule joins letters with
punctuation that no letter follows.
"""

from __future__ import annotations

import re
import string
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space next to other white space: such a text is encoded in one piece.
_UNSAFE = re.compile(r"\s | \s")
#: White space but for the space and the line end.
_RARE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
#: Entries in a worker's table, and the length up to which it keeps chunks.
KEEP, KEEP_LENGTH = 500_000, 64
#: Characters of texts that go through at once.
SLICE = 4_000_000

#: ASCII punctuation, and the words that are encoded as one string.
_PUNCTUATION = string.punctuation
GROUP = 200

_loaded: dict = {}


def unsafe(text: str) -> bool:
    return ("  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE)) and _UNSAFE.search(text) is not None


class ChunkEncoder:
    """``encode_many`` takes strings and returns one ``bytes`` of little-endian unsigned 32-bit ids for each.

    ``spaced``: the vocabulary keeps a space with the word after it, and chunks lack the space before them; else
    white space is dropped. ``words``, if given, encodes chunks that are letters alone, with the space.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], spaced: bool, words: Callable[[list[str]], Iterable[bytes]] | None = None):
        self.encode_many, self.spaced, self.words = encode_many, spaced, words
        #: The table: distinct chunks, their ids one after the other, and where those of each begin.
        self.chunks, self.ids, self.starts = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as bytes."""
        for ids, ends in self.slices(texts):
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                yield raw[4 * at : 4 * end]
                at = end

    def slices(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of one text after the other, and where each text ends. Texts go through in slices, which bounds what
        is in memory; a slice has at least one text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE):
                chars, end = chars + len(texts[end]), end + 1
            yield self._slice(texts[at:end])
            at = end

    def _learn(self, new: list[str], cores: list[str], rows: list[int]) -> None:
        """Puts new chunks at the end of the table, in their order, and after them words that were met in them. ``cores``
        are the chunks without the punctuation at their ends, ``rows`` those of the table where these are, or -1."""
        lead = " " if self.spaced else ""
        if self.words is None:
            raw = list(self.encode_many([lead + c for c in new]))
        else:
            parted = list(map(str.isalpha, cores))
            whole = iter(list(self.encode_many([lead + c for c, p in zip(new, parted) if not p])))
            held_at = dict(zip(compress(cores, parted), compress(rows, parted)))
            fresh = [w for w, j in held_at.items() if j < 0]
            held = dict(zip(fresh, self.words(fresh)))
            held.update((w, self.ids[self.starts[j] : self.starts[j + 1]].tobytes()) for w, j in held_at.items() if j >= 0)
            ends = [c[n:] for c, n in zip(new, map(len, cores))]
            tails = list(set(compress(ends, parted)).difference(self.tails))
            self.tails.update(zip(tails, self.encode_many(tails)))
            tail = self.tails
            raw = [held[k] + tail[e] if p else next(whole) for k, e, p in zip(cores, ends, parted)]
            # A fresh word that isn't itself among the new chunks.
            alone = {k for k, e in zip(cores, ends) if not e}
            more = [c for c in fresh if c not in alone]
            new, raw = [*new, *more], [*raw, *(held[c] for c in more)]
        self.chunks = pa.concat_arrays([self.chunks, pa.array(new, pa.large_string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)])

    def _forget(self, used: np.ndarray) -> None:
        """Once the table is full, only short chunks that the last slice had stay."""
        if len(self.chunks) > KEEP or len(self.ids) > 8 * KEEP:
            keep = np.unique(used)
            keep = keep[np.asarray(pc.utf8_length(self.chunks.take(pa.array(keep)))) <= KEEP_LENGTH]
            size = np.diff(self.starts)[keep]
            ends = np.cumsum(size)
            at = np.repeat(self.starts[keep] - (ends - size), size) + np.arange(int(size.sum()))
            self.chunks, self.ids, self.starts = self.chunks.take(pa.array(keep)), self.ids[at], np.concatenate([[0], ends])
        if len(self.tails) > KEEP:
            self.tails = {"": b""}

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = [i for i, t in enumerate(texts) if unsafe(t)] if self.spaced else []
        values = texts if not apart else [*texts]
        for i in apart:
            values[i] = ""
        strings = pa.array(values, pa.large_string())
        if not self.spaced:
            strings = pc.replace_substring(strings, "\n", " ")
        lists = pc.split_pattern(strings, " ")
        begin = np.asarray(lists.offsets)
        coded = lists.values.dictionary_encode()
        # One look into the table for chunks and their cores, since each builds its hash table anew.
        cores = coded.dictionary if self.words is None else pc.ascii_rtrim(coded.dictionary, characters=_PUNCTUATION)
        asked = coded.dictionary if self.words is None else pa.concat_arrays([coded.dictionary, cores])
        found, n = np.array(pc.index_in(asked, value_set=self.chunks).fill_null(-1)), len(self.chunks)
        known, lacks = found[: len(coded.dictionary)], found[: len(coded.dictionary)] < 0
        if lacks.any():
            of_cores, new = found[len(found) - len(cores) :][lacks].tolist(), pa.array(lacks)
            self._learn(coded.dictionary.filter(new).to_pylist(), cores.filter(new).to_pylist(), of_cores)
            known[lacks] = n + np.arange(int(lacks.sum()))
        ids, first, size = self.ids, self.starts[:-1][known], np.diff(self.starts)[known]
        place = np.asarray(coded.indices)
        if self.spaced:  # the first chunk of a text has no space before it
            heads = lists.values.take(pa.array(begin[:-1])).dictionary_encode()
            raw = list(self.encode_many(heads.dictionary.to_pylist()))
            more = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            place = place.copy()
            place[begin[:-1]] = np.asarray(heads.indices) + len(known)
            first = np.concatenate([first, len(ids) + np.cumsum(more) - more])
            ids, size = np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4")]), np.concatenate([size, more])
        each = size[place]
        upto = np.cumsum(each)
        kind = np.int32 if upto[-1] + len(ids) < 1 << 30 else np.int64
        at = np.repeat((first[place] - (upto - each)).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        out, ends = ids[at], upto[begin[1:] - 1]
        self._forget(known)
        if apart:  # a text in one piece takes the place of its empty stand-in
            own = dict(zip(apart, self.encode_many([texts[i] for i in apart])))
            parts = [np.frombuffer(own[i], "<u4") if i in own else out[a:b] for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist()))]
            out, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return out, ends


def joined(many: Callable[[list[str]], Iterable[bytes]], mark: np.ndarray, spaced: bool) -> Callable[[list[str]], list[bytes]]:
    """Encoder of words, many of them as one string, since a call costs more than a word.

    ``mark`` tells the ids that stand at the start of a word with its space (``spaced``) or at the end of one.
    Where a string hasn't as many of them as words, its words are encoded one by one.
    """
    lead = " " if spaced else ""

    def run(words: list[str]) -> list[bytes]:
        groups = [words[at : at + GROUP] for at in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for group, raw in zip(groups, many([lead + " ".join(g) for g in groups])):
            at = np.flatnonzero(mark[np.frombuffer(raw, "<u4")])
            if len(at) == len(group):
                cuts = [*(4 * at).tolist(), len(raw)] if spaced else [0, *(4 * at + 4).tolist()]
                out.extend([raw[i:j] for i, j in zip(cuts, cuts[1:])])
            else:
                out.extend(many([lead + w for w in group]))
        return out

    return run


def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """Encoder by the ``tokenizers`` library from a vocabulary file, without special tokens. One per worker.

    ``spaced``: the vocabulary keeps a space with the word after it (byte-level); else white space is dropped.
    """
    if path not in _loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        def many(texts: list[str]) -> Iterator[bytes]:
            for at in range(0, len(texts), 5000):
                for e in tok.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()

        mark = np.zeros(tok.get_vocab_size() + 1, bool)
        mark[[i for t, i in tok.get_vocab().items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        _loaded[path] = ChunkEncoder(many, spaced, joined(many, mark, spaced))
    return _loaded[path]
